"""caretlake: text-completion analytics as PySpark DataFrame jobs.

Context windows around cursors, cloze prompts, completion as a batch job, replay of
logged editor sessions, and the reports that go with them.
"""

__version__ = "0.1.0"
