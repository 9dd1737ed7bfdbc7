"""Plan shapes shared by operators that look at neighbouring rows."""
