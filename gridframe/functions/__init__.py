"""Column builders for arrays with named axes."""
