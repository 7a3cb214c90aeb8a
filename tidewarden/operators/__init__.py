"""Table jobs. Every job takes an explicit `as_of`; none reads the wall clock."""
