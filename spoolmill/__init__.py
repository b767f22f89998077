"""A PySpark engine that archives, cleans, searches and exports conversational and terminal logs."""
