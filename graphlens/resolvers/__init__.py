"""Resolvers: facts about a source tree as node and edge tables, each a DataFrame job over the declarations."""
