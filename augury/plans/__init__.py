"""Named queries: each takes a session and a table folder and gives a lazy DataFrame."""
