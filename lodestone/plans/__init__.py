"""Plan helpers: tables read by name, cut lineage, checked broadcasts."""
