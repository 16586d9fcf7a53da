"""DataFrame operators over captures, steps, token rows and run reports."""
