"""Where nodes, edges, text and repository states come from."""
