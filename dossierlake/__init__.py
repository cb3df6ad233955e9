"""dossierlake: Spark-native analytics over packages of project documents."""
