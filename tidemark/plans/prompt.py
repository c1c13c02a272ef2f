"""Messages for a chat model: rules, the user's earlier turns, evidence and task."""

from __future__ import annotations

from .query_plan import QueryPlan

RULES = (
    "Answer from the numbered evidence alone and in the language of the question. Keep numbers, dates, code, paths and names as the evidence has them, and end each statement that can be checked with its [S number]. "
    "Evidence need not repeat the question's words: map its facts to what is asked, but keep who did what, and ascribe nothing that it doesn't. Say what can be confirmed in part, and say what is missing."
)
TASKS = {
    "enumerate": "List only what the evidence marks as validated facts, one item each, with its source; say so if the list may be incomplete.",
    "several": "Tell the sources apart where several are combined.",
    "plain": "Give the facts that answer the question; summarise but add nothing.",
}
INFERRED = " Mark inferences as such, and rest each on two sources or more."


def messages(query: str, context: str, history: list[dict], plan: QueryPlan, most_history: int = 4) -> list[dict]:
    """System rules, the last user turns (never earlier answers) and the question with its evidence."""
    earlier = [m for m in history if m.get("role") == "user" and str(m.get("content") or "").strip()]
    kind = "enumerate" if plan.operation == "enumerate" else "several" if plan.operation in ("compare", "summarize", "trace", "verify") else "plain"
    task = TASKS[kind] + (INFERRED if plan.answer_mode == "inferred" else "")
    evidence = context or "No validated evidence was found this time, which doesn't mean that the documents hold none."
    return [
        {"role": "system", "content": RULES},
        *({"role": "user", "content": str(m["content"])} for m in (earlier[-most_history:] if most_history > 0 else [])),
        {"role": "user", "content": f"[Evidence]\n{evidence}\n\n[Question]\n{query}\n\n[Task]\n{task}"},
    ]
