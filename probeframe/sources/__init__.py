"""The capture store, its byte codec and file sources."""
