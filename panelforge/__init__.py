"""Point-in-time panel analytics as DataFrame-to-DataFrame functions on Spark."""
