"""Structured Streaming forms of the log operators: an extension, as logs here are otherwise read whole."""
