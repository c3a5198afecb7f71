"""Physical-plan helpers and the catalog of registered queries."""
