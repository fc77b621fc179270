"""Job phases and publications as streams."""
