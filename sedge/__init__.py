"""sedge: analytics for binary sequence classifiers, written as Spark DataFrame plans."""
