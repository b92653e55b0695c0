"""The same measures as Structured Streaming jobs with watermarks."""
