"""parley: conversation-timeline analytics expressed as Spark plans."""
