"""DataFrame operators: plain ``DataFrame -> DataFrame`` functions."""
