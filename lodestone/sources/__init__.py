"""Where tables come from: files, frames, rows in memory, callbacks, and the engine's own store."""
