"""lectern: governed document analytics as DataFrame operators on Spark."""
