"""memlake: conversation-memory analytics and corpus preparation on PySpark."""
