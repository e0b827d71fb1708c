"""Registered queries; each reads whole tables or the views of ``plans.views`` over them."""
