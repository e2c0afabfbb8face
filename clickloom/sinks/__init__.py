"""Writers for logs, images and models."""
