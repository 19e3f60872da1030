"""What facts about source code mean as nodes and edges."""
