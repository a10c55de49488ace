"""DataFrame-to-DataFrame operators. None of them runs a job unless its docstring says so."""
