"""Point-in-time task history, calibrated requests and audit planning as Spark DataFrame jobs."""
