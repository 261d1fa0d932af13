"""Plan-shape helpers, the registered queries and their SQL twins."""
