"""snapfeed: page snapshots -> items -> change feeds, as Spark jobs.

Subpackages:
  functions  - column functions (strip, NFC, hashes, content text, URLs, hosts)
  operators  - DataFrame operators (extraction, dedupe, diff, runs, sources, views, repair)
  sources    - readers and writers (driver tables, YAML configs, versioned item state)
  plans      - the registered queries over the driver's tables
  streaming  - Structured Streaming forms (change feed, run timeouts, first-wins)
"""

__version__ = "0.1.0"
