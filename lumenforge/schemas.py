"""Schemas of the annotation tables, as DDL."""

from __future__ import annotations

QA = "scene_id STRING, question STRING, answers ARRAY<STRING>, type INT"
PREDICTIONS = "question_id BIGINT, answer STRING"
QUESTIONS = "info STRING, task_type STRING, data_type STRING, data_subtype STRING, questions ARRAY<STRUCT<question_id: BIGINT, question: STRING, multiple_choices: ARRAY<STRING>>>"
ANNOTATIONS = "annotations ARRAY<STRUCT<question_id: BIGINT, image_id: BIGINT, question_type: STRING, answer_type: STRING, answers: ARRAY<STRUCT<answer_id: INT, answer: STRING>>>>"
MULTIPLE_CHOICE = "image STRING, question STRING, question_id STRING, choices ARRAY<STRING>, correct_choice_idx INT, direct_answers ARRAY<STRING>"
DIALOGUES = "dialogs ARRAY<STRUCT<image_id: STRING, image: STRING, caption: STRING, summary: STRING, dialog: ARRAY<STRUCT<question: STRING, answer: STRING>>>>"
RETRIEVAL = "image STRING, caption ARRAY<STRING>"
BOXES = "class_name STRING, bbox ARRAY<DOUBLE>"
POSE = "rotation ARRAY<DOUBLE>, translation ARRAY<DOUBLE>"
CAMERA = "base_dir STRING, view_params MAP<STRING, STRUCT<intrinsic: ARRAY<ARRAY<DOUBLE>>, extrinsic: ARRAY<ARRAY<DOUBLE>>>>"
PANOPTIC = "annotations ARRAY<STRUCT<image_id: STRING, file_name: STRING, segments_info: ARRAY<STRUCT<id: INT, category_id: INT, iscrowd: INT>>>>"
