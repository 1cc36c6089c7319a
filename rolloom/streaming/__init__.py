"""Flow of samples: bounded queues, staleness, count gates, replay."""
