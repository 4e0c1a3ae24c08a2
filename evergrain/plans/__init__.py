"""The library's queries over the driver's tables, each with its SQL."""
