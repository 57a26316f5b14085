"""Where reports go: JSON, CSV, Markdown, HTML, profiles and manifests."""
