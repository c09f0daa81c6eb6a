"""From a table to decisions, findings, plans and approved changes; and the registered queries."""
