"""Training-data pipeline operators: ten Spark jobs over web pages and documents."""
