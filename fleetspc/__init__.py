"""Statistical process control on equipment sensor data, as Spark DataFrame functions."""
