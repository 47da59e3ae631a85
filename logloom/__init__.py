"""Change-log analytics on Spark: DataFrame operators over event, file and id-interval tables."""
