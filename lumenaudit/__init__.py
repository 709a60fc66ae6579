"""lumenaudit: media-forensics analytics as PySpark DataFrame jobs."""
