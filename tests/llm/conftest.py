from llm_data import edge, nothing, tables  # noqa: F401
