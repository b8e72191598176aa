"""DataFrame operators: extraction, dedupe, diff, runs, sources, views, config checks, repair."""
