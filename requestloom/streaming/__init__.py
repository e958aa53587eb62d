"""The narrow operators over streams: files are handled as they arrive."""
