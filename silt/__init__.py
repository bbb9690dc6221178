"""silt: composable, Spark-native data-processing operators."""
