"""Plan-time building blocks: pages, keysets, budgets, cursors."""
