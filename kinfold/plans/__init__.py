"""Physical planning helpers: scratch tables in the shared folder."""
