"""Table-in, table-out operators: profile, laws, frequencies, dependence, draws."""
