"""The daily schedule and the registered queries with their reference SQL."""
