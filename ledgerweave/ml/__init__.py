"""Models trained with Spark ML, calibration and explanation."""
