"""What comes from outside: this package on executors, audio files, stand-in tables."""
