"""Column functions: text in, Column out, no UDF unless the module says so."""
