"""Readers and writers of manifests, caches, images and pages."""
