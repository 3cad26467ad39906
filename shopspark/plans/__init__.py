"""Rules, domain views and composed jobs."""
