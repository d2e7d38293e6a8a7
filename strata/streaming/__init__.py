"""Nothing streams: a run reads a finished history and is a batch from end to end."""
