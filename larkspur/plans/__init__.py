"""Queries over whole tables: what each computes, and the SQL that checks it."""
