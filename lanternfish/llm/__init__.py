"""lanternfish.llm"""
