"""Rowmill: a Spark-native engine that repairs, joins, routes and audits entity records, every step a DataFrame transform."""
