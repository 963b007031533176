"""Where rows come from and go to: table specifications, predicates, catalog, sinks."""
