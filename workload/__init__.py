"""The registered queries: each check on the given tables, with the SQL that answers it."""
