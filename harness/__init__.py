"""What the driver and the tests run: fixture tables and packages, and the queries on them."""
