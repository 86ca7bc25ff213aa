"""Reports from the few rows that a profile has: text, Markdown, HTML, CSV and charts."""
