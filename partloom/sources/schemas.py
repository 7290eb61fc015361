"""Schemas of the input documents. Unknown keys are ignored, missing ones read as null."""

IMAGE = "struct<id:bigint,coco_url:string,width:bigint,height:bigint>"
CATEGORY = "struct<id:bigint,name:string>"
# A segmentation is a list of polygons, a run-length record, or absent; what it is shows only in each value.
SEGMENTATION = """struct<kind:string,num_polygons:bigint,polygons:array<array<double>>,first_polygon_len:bigint,
counts:array<bigint>,encoded_counts:string,size:array<bigint>>"""


def annotation(identifier: str, segmentation: str) -> str:
    return f"struct<id:{identifier},image_id:bigint,category_id:bigint,bbox:array<double>,area:double,segmentation:{segmentation}>"


MANIFEST_ROW = """struct<sample_id:bigint,object_id:string,geo_cache_path:string,vlm_cache_path:string,
vlm_cache_index:bigint,target_index:bigint,category_name:string,part_name:string,instruction:string,
eval_group:string,instruction_split:string,object_split:string,category_split:string>"""

PART_PROMPTS = """object_id string, object_name string, model_name string,
parts array<struct<part_name:string,prompt:string,base_prompt:string>>"""

CAMERAS = """object_id string, views array<struct<view_id:string,yaw_deg:double,pitch_deg:double,radius:double,
fov_deg:double,resolution:bigint,extrinsics:array<array<double>>,intrinsics:array<array<double>>>>"""

SEGMENTATION_META = """object_id string, status string,
targets array<struct<view_id:string,image_path:string,part_name:string,prompt:string,mask_path:string>>,
target_results array<struct<view_id:string,part_name:string,prompt:string,mask_path:string,score:double,
box_xyxy:array<double>,has_mask:boolean>>"""

SOURCE_META = """object_id string, split_name string, annotation_id bigint, image_id bigint, category_id bigint,
category_name string, original_image_path string, image_size struct<width:bigint,height:bigint>,
bbox_xywh array<double>, area double"""

PROGRESS = "unit string, status string, num_records bigint"
