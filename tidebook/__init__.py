"""Exchange-state analytics on Spark: DataFrame operators over accounts, markets, fills, books and pools."""
