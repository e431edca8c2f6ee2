"""One Spark query per operator, and the SQL that states the same result."""
