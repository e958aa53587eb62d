"""A pure scorer, used where a deterministic stand-in for the model call is needed."""

from __future__ import annotations

from ..operators.infer import ScoringError


def make_length_scorer():
    """Answers with the length of the prompt; every seventh length is refused."""

    def score(record_id: str, model_input: dict) -> dict:
        text = model_input["messages"][0]["content"][0]["text"]
        n = len(text)
        if n % 7 == 0:
            raise ScoringError("bad input", code=429, retryable=True)
        if "anthropic_version" in model_input:
            return {
                "content": [{"type": "text", "text": f"chars={n}"}],
                "stop_reason": "end_turn",
                "usage": {"input_tokens": n, "output_tokens": n % 10},
            }
        return {
            "output": {"message": {"content": [{"text": f"chars={n}"}]}},
            "stopReason": "end_turn",
            "usage": {"inputTokens": n, "outputTokens": n % 10},
        }

    return score
