"""How a model is served and addressed; no data operation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class InferenceClient:
    """The address of an inference endpoint; it makes no calls."""

    base_url: str


def build_vllm_command(model_path: str, port: int = 8000) -> list[str]:
    """The command line that serves a model."""
    return ["vllm", "serve", model_path, "--port", str(port)]
