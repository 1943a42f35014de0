"""Training-data operators: language id, secrets, quality, vectors, shards, near copies, leaks, packing, chats, LM scores."""
