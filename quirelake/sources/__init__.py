"""Readers and host-side settings: page images, vocabularies, model files, configuration."""

from .config import Config, load_env
from .images import ensure_bgr, read_pages, scan_folder
from .models import ModelPort, StubModel, list_models, load_vocab, resolve

__all__ = ["Config", "ModelPort", "StubModel", "ensure_bgr", "list_models", "load_env", "load_vocab", "read_pages", "resolve", "scan_folder"]
