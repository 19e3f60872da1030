"""A strict read-only Cypher dialect: text, tokens, tree, checked tree, DataFrame."""
