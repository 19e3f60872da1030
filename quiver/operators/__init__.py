"""Graph operators over :class:`quiver.graph.PropertyGraph`."""
