"""Schemas, and stores for watermarks, routes and manifests."""
