"""Query plans: the compiler from dictionary queries to columns, and the registered queries."""
