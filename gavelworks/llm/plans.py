"""The modules that hold this subpackage's queries and SQL."""

MODULES: list[str] = ["gavelworks.llm.plans_records", "gavelworks.llm.plans_text"]
