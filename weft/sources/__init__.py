"""Where graphs, triples and rows come from and go to."""
