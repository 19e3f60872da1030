"""From changes in repositories to what they touch."""
