"""tidelog: analytics over timestamped recordings, expressed as Spark DataFrame plans."""
