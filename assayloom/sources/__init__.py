"""Reading tables and keeping states."""
