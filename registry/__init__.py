"""Registered queries: each module lists its queries and the SQL that must give the same rows."""
