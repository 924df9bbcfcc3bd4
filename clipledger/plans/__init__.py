"""Planning jobs over a whole media catalogue."""
