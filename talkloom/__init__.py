"""talkloom: conversation analytics on Spark."""
