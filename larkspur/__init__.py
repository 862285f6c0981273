"""A Spark-native analytics engine for chat-style workspaces."""
