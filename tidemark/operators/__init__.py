"""Event operators, each a ``DataFrame -> DataFrame`` function."""
