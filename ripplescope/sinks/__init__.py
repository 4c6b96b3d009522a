"""Reports as JSON, text, Graphviz and HTML. These read small results on the driver; tables stay tables."""
