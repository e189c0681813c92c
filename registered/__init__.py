"""The queries offered to the driver, and the SQL they are checked against."""
