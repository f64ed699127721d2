"""The driver's tables in the role of trip data, and the SQL to check against."""
